"""Word bigrams of long licence texts and headers: each the sorted set of a public text's bigrams, all that a Dice coefficient needs."""

BIGRAMS = {
    'MIT': (
        'a copy|a particular|above copyright|action of|all copies|an action|and associated|and noninfringement|and or|and this|and to|any claim|any kind|any pe'
        'rson|arising from|as is|associated documentation|authors or|be included|be liable|but not|charge to|claim damages|conditions the|connection with|contr'
        'act tort|copies of|copies or|copy modify|copy of|copyright holders|copyright notice|damages or|deal in|dealings in|distribute sublicense|do so|documen'
        'tation files|event shall|express or|files the|fitness for|following conditions|for a|for any|free of|from out|furnished to|granted free|hereby granted'
        '|holders be|implied including|in all|in an|in connection|in no|in the|included in|including but|including without|is furnished|is hereby|is provided|i'
        's without|kind express|liability whether|liable for|limitation the|limited to|merchantability fitness|merge publish|modify merge|no event|noninfringem'
        'ent in|not limited|notice and|notice shall|obtaining a|of any|of charge|of contract|of merchantability|of or|of the|of this|or copyright|or implied|or'
        ' in|or other|or otherwise|or sell|or substantial|or the|other dealings|other liability|otherwise arising|out of|particular purpose|permission is|permi'
        'ssion notice|permit persons|person obtaining|persons to|portions of|provided as|publish distribute|purpose and|restriction including|rights to|sell co'
        'pies|shall be|shall the|so subject|software and|software is|software or|software the|software to|software without|subject to|sublicense and|substantia'
        'l portions|the above|the authors|the following|the rights|the software|the use|the warranties|this permission|this software|to any|to deal|to do|to pe'
        'rmit|to the|to use|to whom|tort or|use copy|use or|warranties of|warranty of|whether in|whom the|with the|without limitation|without restriction|witho'
        'ut warranty'
    ),
    'ISC': (
        'above copyright|action arising|action of|all copies|all implied|all warranties|an action|and fitness|and or|and the|and this|any damages|any purpose|a'
        'ny special|appear in|arising out|as is|author be|author disclaims|be liable|connection with|consequential damages|contract negligence|copies the|copy '
        'modify|copyright notice|damages or|damages whatsoever|data or|direct indirect|disclaims all|distribute this|event shall|fee is|fitness in|for any|from'
        ' loss|granted provided|hereby granted|implied warranties|in all|in an|in connection|in no|including all|indirect or|is and|is hereby|is provided|liabl'
        'e for|loss of|merchantability and|modify and|negligence or|no event|notice and|notice appear|of contract|of merchantability|of or|of this|of use|or an'
        'y|or consequential|or distribute|or in|or other|or performance|or profits|or without|other tortious|out of|performance of|permission notice|permission'
        ' to|profits whether|provided as|provided that|purpose with|regard to|resulting from|shall the|software for|software including|software is|special dire'
        'ct|that the|the above|the author|the software|the use|this permission|this software|to this|to use|tortious action|use copy|use data|use or|warranties'
        ' of|warranties with|whatsoever resulting|whether in|with or|with regard|with the|without fee'
    ),
    'BSD-2-Clause': (
        '1 redistributions|2 redistributions|a particular|above copyright|advised of|and any|and binary|and contributors|and fitness|and on|and or|and the|and '
        'use|any direct|any express|any theory|any way|are disclaimed|are met|are permitted|arising in|as is|be liable|binary form|binary forms|business interr'
        'uption|but not|by the|caused and|code must|conditions and|conditions are|consequential damages|contract strict|contributors as|contributors be|copyrig'
        'ht holder|copyright holders|copyright notice|damages including|data or|direct indirect|disclaimed in|disclaimer 2|disclaimer in|distribution this|docu'
        'mentation and|even if|event shall|exemplary or|express or|fitness for|following conditions|following disclaimer|for a|for any|form must|forms with|goo'
        'ds or|holder or|holders and|however caused|if advised|implied warranties|in any|in binary|in contract|in no|in source|in the|incidental special|includ'
        'ing but|including negligence|indirect incidental|interruption however|is and|is provided|liability or|liability whether|liable for|limited to|list of|'
        'loss of|materials provided|merchantability and|met 1|modification are|must reproduce|must retain|negligence or|no event|not limited|notice this|of con'
        'ditions|of liability|of merchantability|of source|of substitute|of such|of the|of this|of use|on any|or business|or consequential|or contributors|or i'
        'mplied|or other|or otherwise|or profits|or services|or tort|or without|other materials|otherwise arising|out of|particular purpose|permitted provided|'
        'possibility of|procurement of|profits or|provided by|provided that|provided with|purpose are|redistribution and|redistributions in|redistributions of|'
        'reproduce the|retain the|services loss|shall the|software even|software is|source and|source code|special exemplary|strict liability|substitute goods|'
        'such damage|that the|the above|the copyright|the distribution|the documentation|the following|the implied|the possibility|the use|theory of|this list|'
        'this software|to procurement|to the|tort including|use data|use in|use of|warranties including|warranties of|way out|whether in|with or|with the|witho'
        'ut modification'
    ),
    'BSD-3-Clause': (
        '1 redistributions|2 redistributions|3 neither|a particular|above copyright|advised of|and any|and binary|and contributors|and fitness|and on|and or|an'
        'd the|and use|any direct|any express|any theory|any way|are disclaimed|are met|are permitted|arising in|as is|be liable|be used|binary form|binary for'
        'ms|business interruption|but not|by the|caused and|code must|conditions and|conditions are|consequential damages|contract strict|contributors as|contr'
        'ibutors be|contributors may|copyright holder|copyright holders|copyright notice|damages including|data or|derived from|direct indirect|disclaimed in|d'
        'isclaimer 2|disclaimer in|distribution 3|documentation and|endorse or|even if|event shall|exemplary or|express or|fitness for|following conditions|fol'
        'lowing disclaimer|for a|for any|form must|forms with|from this|goods or|holder nor|holder or|holders and|however caused|if advised|implied warranties|'
        'in any|in binary|in contract|in no|in source|in the|incidental special|including but|including negligence|indirect incidental|interruption however|is '
        'and|is provided|its contributors|liability or|liability whether|liable for|limited to|list of|loss of|materials provided|may be|merchantability and|me'
        't 1|modification are|must reproduce|must retain|name of|names of|negligence or|neither the|no event|nor the|not limited|notice this|of conditions|of i'
        'ts|of liability|of merchantability|of source|of substitute|of such|of the|of this|of use|on any|or business|or consequential|or contributors|or implie'
        'd|or other|or otherwise|or profits|or promote|or services|or tort|or without|other materials|otherwise arising|out of|particular purpose|permission th'
        'is|permitted provided|possibility of|prior written|procurement of|products derived|profits or|promote products|provided by|provided that|provided with'
        '|purpose are|redistribution and|redistributions in|redistributions of|reproduce the|retain the|services loss|shall the|software even|software is|softw'
        'are without|source and|source code|special exemplary|specific prior|strict liability|substitute goods|such damage|that the|the above|the copyright|the'
        ' distribution|the documentation|the following|the implied|the name|the names|the possibility|the use|theory of|this list|this software|to endorse|to p'
        'rocurement|to the|tort including|use data|use in|use of|used to|warranties including|warranties of|way out|whether in|with or|with the|without modific'
        'ation|without specific|written permission'
    ),
    'Apache-2.0-header': (
        '0 the|0 unless|2 0|a copy|agreed to|an as|and limitations|any kind|apache license|apache org|applicable law|as is|at http|basis without|by applicable|'
        'compliance with|conditions of|copy of|distributed on|distributed under|either express|except in|express or|file except|for the|governing permissions|h'
        'ttp www|implied see|in compliance|in writing|is basis|is distributed|kind either|language governing|law or|license 2|license at|license for|license is'
        '|license version|license you|licensed under|licenses license|limitations under|may not|may obtain|not use|obtain a|of any|of the|on an|or agreed|or co'
        'nditions|or implied|org licenses|permissions and|required by|see the|software distributed|specific language|the apache|the license|the specific|this f'
        'ile|to in|under the|unless required|use this|version 2|warranties or|with the|without warranties|writing software|www apache|you may'
    ),
    'GPL-2.0-header': (
        '2 of|a particular|and or|any later|any warranty|as published|at your|be useful|but without|by the|can redistribute|distributed in|either version|even '
        'the|fitness for|for a|for more|foundation either|free software|general public|gnu general|hope that|implied warranty|in the|is distributed|is free|it '
        'and|it under|it will|later version|license as|license for|license or|merchantability or|modify it|more details|of merchantability|of the|option any|or'
        ' at|or fitness|or modify|particular purpose|program is|public license|published by|purpose see|redistribute it|see the|software foundation|software yo'
        'u|terms of|that it|the free|the gnu|the hope|the implied|the license|the terms|this program|under the|useful but|version 2|version this|warranty of|wa'
        'rranty without|will be|without any|without even|you can|your option'
    ),
    'GPL-3.0-header': (
        '3 of|a particular|and or|any later|any warranty|as published|at your|be useful|but without|by the|can redistribute|distributed in|either version|even '
        'the|fitness for|for a|for more|foundation either|free software|general public|gnu general|hope that|implied warranty|in the|is distributed|is free|it '
        'and|it under|it will|later version|license as|license for|license or|merchantability or|modify it|more details|of merchantability|of the|option any|or'
        ' at|or fitness|or modify|particular purpose|program is|public license|published by|purpose see|redistribute it|see the|software foundation|software yo'
        'u|terms of|that it|the free|the gnu|the hope|the implied|the license|the terms|this program|under the|useful but|version 3|version this|warranty of|wa'
        'rranty without|will be|without any|without even|you can|your option'
    ),
    'MPL-2.0-header': (
        '0 if|2 0|a copy|at https|can obtain|code form|copy of|distributed with|file you|form is|https mozilla|if a|is subject|license v|mozilla org|mozilla pu'
        'blic|mpl 2|mpl was|not distributed|obtain one|of the|one at|org mpl|public license|source code|subject to|terms of|the mozilla|the mpl|the terms|this '
        'file|this source|to the|v 2|was not|with this|you can'
    ),
    'Zlib': (
        '1 the|2 altered|3 this|a product|acknowledgment in|alter it|altered from|altered source|an acknowledgment|and must|and redistribute|and to|any damages'
        '|any express|any purpose|any source|anyone to|applications and|appreciated but|arising from|as being|as is|as such|authors be|be appreciated|be held|b'
        'e misrepresented|be plainly|be removed|being the|but is|claim that|commercial applications|damages arising|documentation would|event will|express or|f'
        'ollowing restrictions|for any|freely subject|from any|from the|granted to|held liable|if you|implied warranty|in a|in no|in the|including commercial|i'
        's granted|is not|is provided|is without|it and|it freely|liable for|marked as|may not|misrepresented as|misrepresented you|must be|must not|no event|n'
        'ot be|not claim|not required|notice may|of this|or altered|or implied|origin of|original software|permission is|plainly marked|product an|product docu'
        'mentation|provided as|purpose including|redistribute it|removed or|required 2|restrictions 1|software 3|software for|software if|software in|software '
        'is|software must|software permission|source distribution|source versions|subject to|such and|that you|the authors|the following|the origin|the origina'
        'l|the product|the use|this notice|this software|to alter|to anyone|to the|to use|use of|use this|versions must|warranty in|will the|without any|would '
        'be|wrote the|you must|you use|you wrote'
    ),
    'Unlicense': (
        'a compiled|and by|and unencumbered|any means|any purpose|anyone is|as a|binary for|by any|code form|commercial and|commercial or|compile sell|compiled'
        ' binary|copy modify|distribute this|domain anyone|either in|for any|form or|free and|free to|in source|into the|is free|modify publish|non commercial|'
        'or as|or distribute|or non|public domain|publish use|purpose commercial|released into|sell or|software either|software released|source code|the public'
        '|this is|this software|to copy|unencumbered software|use compile'
    ),
}
